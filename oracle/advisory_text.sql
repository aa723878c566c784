, asked AS (
  SELECT codigo, count(DISTINCT programada_id) AS n FROM attendance JOIN planned USING (programada_id)
  WHERE asiste = 2 GROUP BY codigo
), overdue AS (
  SELECT organizador_id AS codigo, count(*) AS m FROM typed
  WHERE fecha_lim >= DATE '1998-06-15' AND tipo = 1 GROUP BY organizador_id
), counts AS (
  SELECT codigo, universidad, coalesce(n, 0) AS n, coalesce(m, 0) AS m
  FROM universities LEFT JOIN asked USING (codigo) LEFT JOIN overdue USING (codigo)
  WHERE codigo <> 0
)
SELECT codigo, universidad,
       CASE WHEN n = 0 AND m = 0 THEN ''
            WHEN m = 0 THEN 'Advertencia: Restan ' || n || ' invitaciones por confirmar asistencia.'
            WHEN n = 0 THEN 'Advertencia: Permanecen ' || m || ' visitas sin confirmación de realización.'
            ELSE 'Advertencia: Restan ' || n || ' invitaciones por confirmar asistencia y '
                 || m || ' visitas sin confirmación de realización.' END AS texto
FROM counts
