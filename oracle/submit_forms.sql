, used AS (
  SELECT fecha, count(*) AS n FROM visits WHERE estatus IN ('Confirmada', 'Por confirmar') GROUP BY fecha
), moves AS (
  -- Forms that hold an unfit value have left the queue.
  SELECT programada_id, fecha + 7 AS destino, estatus IN ('Confirmada', 'Por confirmar') AS ocupa
  FROM visits WHERE observaciones = '1-URGENT' AND programada_id % 13 <> 0 AND programada_id % 17 <> 0
), decided AS (
  SELECT programada_id, destino,
         coalesce(n, 0) + coalesce(sum(CASE WHEN ocupa THEN 1 ELSE 0 END) OVER (
           PARTITION BY destino ORDER BY programada_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) < (SELECT places FROM season) AS cabe
  FROM moves LEFT JOIN used ON used.fecha = destino
)
SELECT v.* REPLACE (
  CASE WHEN entra AND observaciones = '1-URGENT' THEN fecha + 7 ELSE fecha END AS fecha,
  CASE WHEN entra AND observaciones = '2-HIGH' THEN 'Confirmada' ELSE estatus END AS estatus,
  CASE WHEN entra AND observaciones = '3-MEDIUM' THEN NULL ELSE hora_ini END AS hora_ini,
  CASE WHEN entra AND programada_id % 19 = 0 THEN '09:05:00' ELSE hora_fin END AS hora_fin,
  CASE WHEN entra AND observaciones = '5-LOW' THEN 'Urgente' ELSE observaciones END AS observaciones)
FROM visits v JOIN (
  SELECT v.programada_id AS id, v.programada_id % 13 <> 0 AND v.programada_id % 17 <> 0 AND coalesce(cabe, TRUE) AS entra
  FROM visits v LEFT JOIN decided USING (programada_id)) ON id = programada_id
