SELECT programada_id, fecha, nombre FROM visits WHERE isodow(fecha) > 5
