SELECT programada_id, m.fecha, activas
FROM (SELECT programada_id, fecha + CAST(programada_id % 3 AS INTEGER) AS fecha FROM visits) m
JOIN (SELECT fecha, count(*) AS activas FROM visits WHERE estatus IN ('Confirmada', 'Por confirmar') GROUP BY fecha) b
  ON b.fecha = m.fecha AND activas >= (SELECT places FROM season)
