SELECT organizador_id, count(*) AS pendientes
FROM typed WHERE fecha_lim >= DATE '1998-06-15' AND tipo = 1
GROUP BY organizador_id
