SELECT * REPLACE (CAST(CASE WHEN asiste = 2 THEN (programada_id + codigo) % 2 ELSE invitacion END AS INTEGER) AS invitacion)
FROM attendance
