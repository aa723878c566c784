SELECT programada_id, organizador_id, CAST(tipo AS INTEGER) AS tipo,
       fecha >= DATE '1998-06-15' AS respuesta_editable,
       fecha_lim >= DATE '1998-06-15' AND tipo IN (0, 3) AS visita_editable,
       fecha_lim >= DATE '1998-06-15' AND tipo IN (1, 2) AS realizacion_confirmable
FROM typed
