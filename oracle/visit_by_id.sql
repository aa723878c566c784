SELECT * FROM visits WHERE programada_id IN (SELECT l_orderkey FROM lineitem)
