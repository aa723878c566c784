SELECT programada_id, orden, fecha, rbd, nombre, organizador_id, organizador, estatus
FROM visits WHERE month(fecha) = 6
ORDER BY fecha, orden, programada_id
