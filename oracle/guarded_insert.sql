, requests AS (
  SELECT l_orderkey AS seq, CAST(min(l_shipdate) AS DATE) AS fecha, min(l_suppkey) AS rbd,
         CASE WHEN l_orderkey % 5 = 0 THEN 'Suspendida' ELSE 'Por confirmar' END AS estatus
  FROM lineitem GROUP BY l_orderkey
), queue AS (
  SELECT r.*, CASE WHEN seq % 3 = 0 THEN v.fecha END AS fecha_propia
  FROM requests r LEFT JOIN visits v ON v.programada_id = seq
), used AS (
  SELECT fecha, count(*) AS n FROM visits WHERE estatus IN ('Confirmada', 'Por confirmar') GROUP BY fecha
), counted AS (
  -- places asked for on the date before this request
  SELECT q.*, coalesce(n, 0) AS n,
         coalesce(sum(CASE WHEN coalesce(rbd, 0) <> 0 AND estatus = 'Por confirmar'
                            AND fecha_propia IS DISTINCT FROM q.fecha THEN 1 ELSE 0 END)
                  OVER (PARTITION BY q.fecha ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS antes
  FROM queue q LEFT JOIN used ON used.fecha = q.fecha
)
SELECT seq, fecha, rbd, estatus, fecha_propia,
       CASE WHEN coalesce(rbd, 0) = 0 THEN 'ignorada'
            WHEN fecha_propia = fecha THEN 'aceptada'
            WHEN n + antes >= (SELECT places FROM season) THEN 'rechazada' ELSE 'aceptada' END AS decision
FROM counted
