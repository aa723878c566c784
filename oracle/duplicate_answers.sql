SELECT l_orderkey AS programada_id, CAST(l_suppkey AS INTEGER) AS codigo, count(*) AS filas
FROM lineitem GROUP BY ALL HAVING count(*) > 1
