SELECT CAST(month(fecha) AS INTEGER) AS mes, CAST(day(fecha) AS INTEGER) AS dia,
       row_number() OVER (PARTITION BY month(fecha), day(fecha) ORDER BY fecha, orden, programada_id) AS n,
       programada_id, substring(nombre, 1, 40) AS nombre
FROM visits
