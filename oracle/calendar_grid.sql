, months AS (
  SELECT DISTINCT CAST(date_trunc('month', fecha) AS DATE) AS mes FROM visits
), days AS (
  SELECT mes, CAST(unnest(generate_series(mes, last_day(mes), INTERVAL 1 DAY)) AS DATE) AS fecha FROM months
), cells AS (
  SELECT mes, fecha,
         CAST(dense_rank() OVER (PARTITION BY mes ORDER BY date_trunc('week', fecha)) - 1 AS INTEGER) AS fila,
         CAST(isodow(fecha) - 1 AS INTEGER) AS columna
  FROM days WHERE isodow(fecha) <= 5
)
SELECT mes, c.fecha, fila, columna,
       CASE WHEN v.programada_id IS NOT NULL
            THEN row_number() OVER (PARTITION BY c.fecha ORDER BY v.orden, v.programada_id) END AS n,
       substring(nombre, 1, 40) AS nombre
FROM cells c LEFT JOIN visits v ON v.fecha = c.fecha
