, urgent AS (
  SELECT *, programada_id % 13 = 0 AS suspende FROM visits WHERE observaciones = '1-URGENT'
), queue AS (
  SELECT 4 * programada_id AS seq, programada_id, fecha + CAST(programada_id % 3 AS INTEGER) AS fecha,
         CASE WHEN suspende THEN 'Suspendida' ELSE estatus END AS estatus, CAST(NULL AS BIGINT) AS rbd FROM urgent
  UNION ALL
  SELECT 4 * programada_id + 2, programada_id, fecha + CAST(2 - programada_id % 3 AS INTEGER),
         CASE WHEN suspende THEN 'Suspendida' ELSE estatus END, NULL FROM urgent WHERE programada_id % 4 = 0
  UNION ALL
  SELECT 4 * l_orderkey + 1, NULL, CAST(min(l_shipdate) AS DATE),
         CASE WHEN l_orderkey % 5 = 0 THEN 'Suspendida' ELSE 'Por confirmar' END, min(l_suppkey)
  FROM lineitem WHERE l_orderkey % 6 = 0 GROUP BY l_orderkey
), asked AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY seq) AS turn, q.seq, CAST(q.programada_id AS BIGINT) AS visit, epoch_ms(q.fecha::TIMESTAMP) // 86400000 AS day,
         (q.estatus IN ('Confirmada', 'Por confirmar'))::BIGINT AS takes, epoch_ms(v.fecha::TIMESTAMP) // 86400000 AS own,
         coalesce((v.estatus IN ('Confirmada', 'Por confirmar'))::BIGINT, 0) AS held,
         q.fecha IS NULL OR (q.programada_id IS NULL AND coalesce(q.rbd, 0) = 0)
           OR (q.programada_id IS NOT NULL AND v.programada_id IS NULL) AS out_
  FROM queue q LEFT JOIN visits v ON v.programada_id = q.programada_id
), used AS (
  SELECT epoch_ms(fecha::TIMESTAMP) // 86400000 AS day, count(*) AS n FROM visits
  WHERE estatus IN ('Confirmada', 'Por confirmar') AND fecha IS NOT NULL GROUP BY fecha
), places AS (SELECT places FROM season)
-- One request after the other: counts of dates (0), visits that moved (1: day, then whether they hold a place),
-- decisions (2) and the turn (3) are kept by key.
SELECT q.*, CASE d.a WHEN 0 THEN 'ignorada' WHEN 1 THEN 'aceptada' ELSE 'rechazada' END AS decision
FROM (
  WITH RECURSIVE run(kind, key, a, b) USING KEY (kind, key) AS (
    SELECT 0, day, n::BIGINT, 0::BIGINT FROM used
    UNION ALL SELECT 3, 0::BIGINT, 0::BIGINT, 0::BIGINT
    UNION
    (WITH step AS (
      SELECT asked.* REPLACE (coalesce(m.a, own) AS own, coalesce(m.b, held) AS held), coalesce(t.a, 0) AS there
      FROM run r JOIN asked ON r.kind = 3 AND asked.turn = r.a + 1
      LEFT JOIN recurring.run m ON m.kind = 1 AND m.key = visit
      LEFT JOIN recurring.run t ON t.kind = 0 AND t.key = day
    ), judged AS (
      SELECT *, CASE WHEN out_ THEN 0 WHEN own IS NOT DISTINCT FROM day OR there < (SELECT places FROM places) THEN 1 ELSE 2 END AS d FROM step
    )
    SELECT 3, 0::BIGINT, turn, 0::BIGINT FROM judged
    UNION ALL SELECT 2, seq, d::BIGINT, 0::BIGINT FROM judged
    UNION ALL SELECT 1, visit, day, takes FROM judged WHERE d = 1 AND visit IS NOT NULL
    UNION ALL SELECT 0, day, there + takes, 0::BIGINT FROM judged WHERE d = 1 AND own IS DISTINCT FROM day
    UNION ALL SELECT 0, own, o.a - held, 0::BIGINT
              FROM judged JOIN recurring.run o ON o.kind = 0 AND o.key = own WHERE d = 1 AND own IS DISTINCT FROM day)
  ) SELECT * FROM run
) d JOIN queue q ON d.kind = 2 AND d.key = q.seq
