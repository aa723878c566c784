SELECT codigo, count(DISTINCT programada_id) AS invitaciones
FROM attendance JOIN planned USING (programada_id)
WHERE asiste = 2 GROUP BY codigo
