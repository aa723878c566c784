SELECT programada_id AS seq, programada_id, 'patch' AS accion, 'color' AS campo, 'rojo' AS valor,
       'campo desconocido' AS motivo
FROM visits WHERE programada_id % 29 = 0
UNION ALL
SELECT programada_id, programada_id, 'mover', 'fecha', NULL, 'accion desconocida' FROM visits WHERE programada_id % 29 = 0
UNION ALL
SELECT programada_id, -programada_id - 1, 'patch', 'direccion', 'nadie', 'visita desconocida'
FROM visits WHERE programada_id % 31 = 0
