SELECT * REPLACE (
  CASE WHEN programada_id % 29 = 0 THEN 7 ELSE rbd END AS rbd,
  CASE WHEN observaciones = '1-URGENT' THEN fecha + 7 ELSE fecha END AS fecha,
  CASE WHEN observaciones = '2-HIGH' THEN 'Confirmada' ELSE estatus END AS estatus,
  CASE WHEN observaciones = '3-MEDIUM' THEN NULL ELSE hora_ini END AS hora_ini,
  CASE WHEN observaciones = '5-LOW' THEN 'Urgente' ELSE observaciones END AS observaciones)
FROM visits WHERE NOT (estatus = 'Suspendida' AND fecha < DATE '1998-06-15')
