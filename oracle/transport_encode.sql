SELECT * REPLACE (strftime(fecha, '%Y-%m-%d') AS fecha, strftime(fecha_lim, '%Y-%m-%d') AS fecha_lim) FROM visits
