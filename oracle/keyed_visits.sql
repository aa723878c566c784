SELECT * FROM visits WHERE programada_id IN (SELECT s_suppkey * 3 FROM supplier)
