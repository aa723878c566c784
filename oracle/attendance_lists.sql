-- Every line is listed; one without a code comes first.
SELECT l_orderkey AS programada_id, asiste,
       string_agg(coalesce(CAST(codigo AS VARCHAR), '-'), ',' ORDER BY codigo NULLS FIRST) AS codigos
FROM (SELECT l_orderkey, CASE WHEN l_suppkey % 7 <> 0 THEN l_suppkey % 25 END AS codigo,
             CASE l_returnflag WHEN 'A' THEN 1 WHEN 'R' THEN 0 ELSE 2 END AS asiste
      FROM lineitem)
GROUP BY l_orderkey, asiste
