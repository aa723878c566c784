SELECT programada_id AS seq, programada_id, 'hora_ini' AS campo FROM visits WHERE programada_id % 13 = 0
UNION ALL SELECT programada_id, programada_id, 'fecha' FROM visits WHERE programada_id % 17 = 0
