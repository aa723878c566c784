SELECT codigo,
       NOT EXISTS (SELECT 1 FROM attendance a JOIN planned USING (programada_id)
                   WHERE a.codigo = u.codigo AND asiste = 2)
       AND NOT EXISTS (SELECT 1 FROM typed t WHERE t.organizador_id = u.codigo
                       AND fecha_lim >= DATE '1998-06-15' AND tipo = 1) AS oculta
FROM universities u WHERE codigo <> 0
