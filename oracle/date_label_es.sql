SELECT programada_id, fecha, etiqueta_fecha AS etiqueta
FROM visits JOIN labelled ON etiquetada = programada_id
