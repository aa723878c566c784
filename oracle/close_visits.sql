, closings AS (
  SELECT 2 * programada_id AS seq, programada_id, fecha + CAST(programada_id % 5 AS INTEGER) AS hoy,
         CASE WHEN observaciones = '1-URGENT' THEN 'Suspendida' ELSE 'Realizada' END AS nuevo
  FROM visits WHERE fecha < DATE '1998-06-15'
  UNION ALL
  SELECT 2 * programada_id + 1, programada_id, fecha + 4 - CAST(programada_id % 7 AS INTEGER), 'Confirmada'
  FROM visits WHERE fecha < DATE '1998-06-15' AND programada_id % 3 = 0
), open_days AS (
  SELECT hoy, dia, row_number() OVER (PARTITION BY hoy ORDER BY dia) - 1 AS k
  FROM (SELECT hoy, hoy + CAST(i AS INTEGER) AS dia FROM (SELECT DISTINCT hoy FROM closings), generate_series(0, 13) g(i))
  WHERE dia NOT IN (SELECT fecha FROM holidays)
), acting AS (
  -- One after the other: a closing acts where it changes the status before it.
  SELECT c.programada_id, c.seq, nuevo, dia,
         nuevo <> coalesce(lag(nuevo) OVER (PARTITION BY c.programada_id ORDER BY c.seq), v.estatus) AS cambia
  FROM closings c JOIN visits v ON v.programada_id = c.programada_id JOIN open_days o ON o.hoy = c.hoy AND k = 1
), closed AS (
  SELECT programada_id, arg_max(nuevo, seq) AS ultimo, min(dia) FILTER (cambia) AS limite FROM acting GROUP BY programada_id
)
SELECT v.* REPLACE (coalesce(ultimo, estatus) AS estatus, least(fecha_lim, limite) AS fecha_lim)
FROM visits v LEFT JOIN closed USING (programada_id)
