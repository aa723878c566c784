, days AS (
  SELECT DISTINCT fecha AS hoy, make_date(year(fecha), 3, 1) AS inicio FROM visits
), starts AS (
  SELECT hoy AS fecha FROM days UNION SELECT inicio FROM days
), habil AS (
  SELECT fecha, min(dia) AS dia
  FROM (SELECT fecha, fecha + CAST(i AS INTEGER) AS dia FROM starts, generate_series(0, 13) g(i))
  WHERE dia NOT IN (SELECT fecha FROM holidays_and_closure)
  GROUP BY fecha
)
SELECT hoy, inicio, CASE WHEN a.dia >= b.dia THEN a.dia WHEN b.dia > a.dia THEN b.dia END AS fecha,
       CAST(month(CASE WHEN a.dia >= b.dia THEN a.dia WHEN b.dia > a.dia THEN b.dia END) AS INTEGER) AS mes
FROM days LEFT JOIN habil a ON a.fecha = hoy LEFT JOIN habil b ON b.fecha = inicio
