SELECT programada_id, CAST(month(fecha) AS INTEGER) AS mes,
       CAST(greatest(3, month(fecha)) AS INTEGER) AS mes_calendario,
       '(' || strftime(fecha, '%-d %b %Y') || ')' AS nota_fecha,
       '(' || coalesce(hora_ini, '') || ')' AS nota_hora,
       list_value('Ene', 'Feb', 'Mar', 'Abr', 'May', 'Jun', 'Jul', 'Ago', 'Sep', 'Oct', 'Nov', 'Dic')[month(fecha)] AS mes_corto
FROM visits
