SELECT programada_id, 'fecha' AS campo, '1997-02-30' AS valor FROM visits WHERE programada_id % 7 = 0
UNION ALL
SELECT programada_id, 'hora_ini', '24:00:00' FROM visits WHERE programada_id % 5 <> 0 AND programada_id % 13 = 0
