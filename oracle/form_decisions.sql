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
SELECT programada_id AS seq, destino AS fecha, CASE WHEN cabe THEN 'aceptada' ELSE 'rechazada' END AS decision FROM decided
