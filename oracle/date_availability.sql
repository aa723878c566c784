, blocked AS (
  SELECT fecha FROM visits
  WHERE estatus IN ('Confirmada', 'Por confirmar') GROUP BY fecha HAVING count(*) >= (SELECT places FROM season)
), moves AS (
  SELECT programada_id, fecha + CAST(programada_id % 3 AS INTEGER) AS fecha, fecha AS fecha_propia FROM visits
)
SELECT programada_id, fecha, fecha_propia,
       fecha IN (SELECT fecha FROM blocked) AND fecha <> fecha_propia AS bloqueada
FROM moves
