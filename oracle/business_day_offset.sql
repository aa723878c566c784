, starts AS (
  SELECT DISTINCT fecha FROM visits
), open_days AS (
  SELECT fecha, dia, row_number() OVER (PARTITION BY fecha ORDER BY dia) - 1 AS k
  FROM (SELECT fecha, fecha + CAST(i AS INTEGER) AS dia FROM starts, generate_series(0, 13) g(i))
  WHERE dia NOT IN (SELECT fecha FROM holidays_and_closure)
)
SELECT s.fecha, dia AS habil FROM starts s LEFT JOIN open_days o ON o.fecha = s.fecha AND k = 1
