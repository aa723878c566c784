SELECT programada_id AS "ID", fecha AS "Fecha", rbd AS "RBD", nombre AS "Colegio",
       organizador AS "Organizador", estatus AS "Estatus"
FROM visits ORDER BY fecha, orden, programada_id
