SELECT programada_id, fecha, nombre, estatus FROM visits WHERE nombre ILIKE '%r#0000001%' AND estatus ILIKE '%irm%'
