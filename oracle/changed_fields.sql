SELECT programada_id, 'fecha' AS campo, strftime(fecha, '%Y-%m-%d') AS anterior,
       strftime(fecha + 7, '%Y-%m-%d') AS nuevo
FROM visits WHERE observaciones = '1-URGENT'
UNION ALL
SELECT programada_id, 'estatus', estatus, 'Confirmada' FROM visits
WHERE observaciones = '2-HIGH' AND estatus <> 'Confirmada'
UNION ALL
SELECT programada_id, 'hora_ini', hora_ini, CAST(NULL AS VARCHAR) FROM visits
WHERE observaciones = '3-MEDIUM' AND hora_ini IS NOT NULL
UNION ALL
SELECT programada_id, 'observaciones', observaciones, 'Urgente' FROM visits WHERE observaciones = '5-LOW'
