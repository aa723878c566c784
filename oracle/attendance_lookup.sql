SELECT v.programada_id, v.organizador_id AS codigo,
       CASE WHEN v.organizador_id <> 0 THEN a.asiste END AS asiste,
       v.organizador_id = 0 OR a.codigo IS NOT NULL AS hallada
FROM visits v LEFT JOIN attendance a ON a.programada_id = v.programada_id AND a.codigo = v.organizador_id
