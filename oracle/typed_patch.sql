SELECT o_orderkey AS programada_id, 'fecha' AS campo,
       CASE WHEN o_orderkey % 7 <> 0 THEN strftime(o_orderdate, '%Y-%m-%d') END AS valor,
       o_orderkey % 7 <> 0 AS valido
FROM orders
UNION ALL
SELECT o_orderkey, 'hora_fin',
       CASE WHEN o_orderkey % 26 < 24
            THEN lpad(CAST(o_orderkey % 26 AS VARCHAR), 2, '0') || ':' || lpad(CAST(o_orderkey % 60 AS VARCHAR), 2, '0') || ':00' END,
       o_orderkey % 26 < 24
FROM orders
UNION ALL
SELECT o_orderkey, 'observaciones', o_orderpriority, TRUE FROM orders
