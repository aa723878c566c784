, months AS (
  SELECT DISTINCT CAST(date_trunc('month', fecha) AS DATE) AS mes FROM visits
), days AS (
  SELECT mes, CAST(unnest(generate_series(mes, last_day(mes), INTERVAL 1 DAY)) AS DATE) AS fecha FROM months
)
SELECT mes, CAST(count(DISTINCT date_trunc('week', fecha)) AS INTEGER) AS filas, CAST(5 AS INTEGER) AS columnas
FROM days WHERE isodow(fecha) <= 5 GROUP BY mes
