, edited AS (
  -- The changes of the visits of 1998.
  SELECT * REPLACE (
    CASE WHEN year(fecha) = 1998 AND observaciones = '1-URGENT' THEN fecha + 7 ELSE fecha END AS fecha,
    CASE WHEN year(fecha) = 1998 AND observaciones = '2-HIGH' THEN 'Confirmada' ELSE estatus END AS estatus,
    CASE WHEN year(fecha) = 1998 AND observaciones = '3-MEDIUM' THEN NULL ELSE hora_ini END AS hora_ini,
    CASE WHEN year(fecha) = 1998 AND observaciones = '5-LOW' THEN 'Urgente' ELSE observaciones END AS observaciones)
  FROM visits WHERE NOT (year(fecha) = 1998 AND estatus = 'Suspendida' AND fecha < DATE '1998-06-15')
)
SELECT organizador_id, programada_id, fecha, nombre,
       row_number() OVER (PARTITION BY organizador_id ORDER BY fecha, orden, programada_id) AS orden
FROM edited WHERE fecha_lim >= DATE '1998-06-15'
