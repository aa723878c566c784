, requests AS (
  SELECT l_orderkey AS seq, CAST(min(l_shipdate) AS DATE) AS fecha, min(l_suppkey) AS rbd,
         CASE WHEN l_orderkey % 5 = 0 THEN 'Suspendida' ELSE 'Por confirmar' END AS estatus
  FROM lineitem GROUP BY l_orderkey
), used AS (
  SELECT fecha, count(*) AS n FROM visits WHERE estatus IN ('Confirmada', 'Por confirmar') GROUP BY fecha
), counted AS (
  SELECT r.*, coalesce(n, 0) + coalesce(sum(CASE WHEN estatus = 'Por confirmar' THEN 1 ELSE 0 END) OVER (
           PARTITION BY r.fecha ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ocupados
  FROM requests r LEFT JOIN used ON used.fecha = r.fecha
  WHERE coalesce(rbd, 0) <> 0
)
-- On insert zero and empty inputs count as missing, a commune 0 as well.
SELECT * FROM visits
UNION ALL BY NAME
SELECT coalesce((SELECT max(orden) FROM visits v WHERE v.fecha = counted.fecha), 0)
         + row_number() OVER (PARTITION BY fecha ORDER BY seq) AS orden,
       (SELECT max(programada_id) FROM visits) + row_number() OVER (ORDER BY seq) AS programada_id,
       CAST(seq % 2 + 1 AS INTEGER) AS organizador_id, universidad AS organizador, fecha, rbd, nombre,
       nullif(cod_com, 0) AS comuna_id, estatus, DATE '2001-12-31' AS fecha_lim
FROM counted LEFT JOIN schools USING (rbd) LEFT JOIN universities ON codigo = seq % 2 + 1
WHERE ocupados < (SELECT places FROM season)
