SELECT programada_id,
       CAST(CASE asiste WHEN 1 THEN 1 WHEN 0 THEN 2 ELSE 3 END AS INTEGER) AS seccion,
       CASE asiste WHEN 1 THEN 'Universidades que asisten:' WHEN 0 THEN 'Universidades que no asisten:'
                   ELSE 'Universidades sin confirmación:' END AS titulo,
       CAST(row_number() OVER (PARTITION BY programada_id, asiste ORDER BY codigo) AS INTEGER) AS n,
       codigo, universidad
FROM attendance LEFT JOIN universities USING (codigo)
