SELECT programada_id, orden, fecha, rbd, nombre, organizador_id, organizador, estatus
FROM visits ORDER BY fecha, orden, programada_id
