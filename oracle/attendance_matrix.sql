SELECT programada_id,
       max(CASE WHEN codigo = 0 THEN situacion END) AS NATION_0,
       max(CASE WHEN codigo = 1 THEN situacion END) AS NATION_1,
       max(CASE WHEN codigo = 2 THEN situacion END) AS NATION_2,
       max(CASE WHEN codigo = 4 THEN situacion END) AS NATION_4,
       max(CASE WHEN codigo = 6 THEN situacion END) AS NATION_6,
       max(CASE WHEN codigo = 7 THEN situacion END) AS NATION_7,
       max(CASE WHEN codigo = 9 THEN situacion END) AS NATION_9,
       max(CASE WHEN codigo = 10 THEN situacion END) AS NATION_10,
       max(CASE WHEN codigo = 11 THEN situacion END) AS NATION_11,
       max(CASE WHEN codigo = 12 THEN situacion END) AS NATION_12,
       max(CASE WHEN codigo = 14 THEN situacion END) AS NATION_14,
       max(CASE WHEN codigo = 15 THEN situacion END) AS NATION_15,
       max(CASE WHEN codigo = 16 THEN situacion END) AS NATION_16,
       max(CASE WHEN codigo = 17 THEN situacion END) AS NATION_17,
       max(CASE WHEN codigo = 18 THEN situacion END) AS NATION_18,
       max(CASE WHEN codigo = 19 THEN situacion END) AS NATION_19,
       max(CASE WHEN codigo = 20 THEN situacion END) AS NATION_20,
       max(CASE WHEN codigo = 21 THEN situacion END) AS NATION_21,
       max(CASE WHEN codigo = 22 THEN situacion END) AS NATION_22,
       max(CASE WHEN codigo = 23 THEN situacion END) AS NATION_23,
       max(CASE WHEN codigo = 24 THEN situacion END) AS NATION_24
FROM (SELECT programada_id, codigo,
               CASE asiste WHEN 0 THEN 'No' WHEN 1 THEN 'Sí' WHEN 2 THEN 'No confirmada' END AS situacion
        FROM attendance)
GROUP BY programada_id
