SELECT codigo, asiste, programada_id,
       row_number() OVER (PARTITION BY codigo, asiste ORDER BY fecha, orden, programada_id) AS orden,
       fecha, rbd, nombre, direccion, comuna, invitacion
FROM attendance JOIN planned USING (programada_id) LEFT JOIN communes USING (comuna_id)
