SELECT s_suppkey * 3 AS programada_id, CAST(s_suppkey % 25 AS INTEGER) AS codigo,
       CASE WHEN s_suppkey % 25 <> 0 THEN asiste END AS asiste, s_suppkey % 25 = 0 OR asiste IS NOT NULL AS hallada
FROM supplier LEFT JOIN attendance a ON a.programada_id = s_suppkey * 3 AND a.codigo = s_suppkey % 25
