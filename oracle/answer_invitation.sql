SELECT * REPLACE (CAST(CASE WHEN asiste = 2 THEN (programada_id + codigo) % 2 ELSE asiste END AS INTEGER) AS asiste)
FROM attendance
