SELECT DISTINCT id AS programada_id
FROM (SELECT l_partkey AS id FROM lineitem UNION ALL SELECT l_partkey * 7 - 500 FROM lineitem)
WHERE id NOT IN (SELECT programada_id FROM visits)
