, requests AS (
  SELECT l_orderkey AS seq, CAST(min(l_shipdate) AS DATE) AS fecha, min(l_suppkey) AS rbd,
         CASE WHEN l_orderkey % 5 = 0 THEN 'Suspendida' ELSE 'Por confirmar' END AS estatus
  FROM lineitem GROUP BY l_orderkey
)
SELECT * FROM visits
UNION ALL BY NAME
SELECT coalesce((SELECT max(orden) FROM visits v WHERE v.fecha = requests.fecha), 0)
         + row_number() OVER (PARTITION BY fecha ORDER BY seq) AS orden,
       (SELECT max(programada_id) FROM visits) + row_number() OVER (ORDER BY seq) AS programada_id,
       fecha, nullif(rbd, 0) AS rbd, estatus, DATE '2001-12-31' AS fecha_lim
FROM requests
