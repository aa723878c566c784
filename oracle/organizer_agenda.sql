SELECT organizador_id, programada_id,
       row_number() OVER (PARTITION BY organizador_id ORDER BY fecha, orden, programada_id) AS orden,
       rbd, nombre, fecha, fecha_lim, tipo, estatus
FROM typed WHERE fecha_lim >= DATE '1998-06-15'
