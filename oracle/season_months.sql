, seasons AS (
  SELECT year(fecha) AS temporada,
         month(CASE WHEN year(fecha) % 2 = 0 THEN min(fecha) - INTERVAL 6 MONTH ELSE min(fecha) END) AS desde,
         month(CASE WHEN year(fecha) % 2 = 0 THEN max(fecha) - INTERVAL 9 MONTH ELSE max(fecha) END) AS hasta
  FROM visits GROUP BY 1
), months AS (
  SELECT * FROM (VALUES (0, 'Todos'), (1, 'Ene'), (2, 'Feb'), (3, 'Mar'), (4, 'Abr'), (5, 'May'), (6, 'Jun'),
    (7, 'Jul'), (8, 'Ago'), (9, 'Sep'), (10, 'Oct'), (11, 'Nov'), (12, 'Dic')) m(value, label)
)
SELECT CAST(temporada AS INTEGER) AS temporada, CAST(value AS INTEGER) AS value, label
FROM seasons JOIN months ON value = 0 OR value BETWEEN desde AND hasta
