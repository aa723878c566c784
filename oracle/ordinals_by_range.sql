SELECT estatus, fecha, programada_id, row_number() OVER (PARTITION BY estatus ORDER BY fecha, programada_id) AS n
FROM visits
