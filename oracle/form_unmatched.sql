SELECT -programada_id - 1 AS seq, -programada_id - 1 AS programada_id FROM visits WHERE programada_id % 23 = 0
