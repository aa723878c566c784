, numbered AS (
  SELECT fecha, programada_id,
         row_number() OVER (PARTITION BY fecha ORDER BY orden, programada_id) AS orden,
         rbd, nombre, organizador, estatus
  FROM visits WHERE estatus IN ('Confirmada', 'Por confirmar')
)
SELECT * FROM numbered WHERE nombre ILIKE '%r#0000001%' AND estatus ILIKE '%por confirm%'
ORDER BY organizador, estatus
