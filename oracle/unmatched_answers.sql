SELECT 2 * programada_id AS seq, -programada_id - 1 AS programada_id, codigo,
       CAST((programada_id + codigo) % 2 AS INTEGER) AS asiste
FROM attendance WHERE asiste = 2
