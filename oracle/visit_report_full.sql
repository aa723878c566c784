, items AS (
  SELECT programada_id, estatus, organizador, nombre, CAST(rbd AS VARCHAR) AS rbd, etiqueta_fecha AS fecha,
         coalesce(direccion, '') AS direccion, comuna, s.etiqueta || ' hrs.' AS hora_ins, i.etiqueta || ' hrs.' AS hora_ini,
         f.etiqueta || ' hrs.' AS hora_fin, coalesce(orientador, '') AS orientador, coalesce(asistentes, '') AS asistentes
  FROM visits JOIN labelled ON etiquetada = programada_id LEFT JOIN communes USING (comuna_id) LEFT JOIN slots i ON i.hora = hora_ini
    LEFT JOIN slots f ON f.hora = hora_fin LEFT JOIN slots s ON s.hora = hora_ins
), lines AS (
  SELECT programada_id, CAST(1 AS INTEGER) AS posicion, 'Estatus' AS etiqueta, estatus AS valor FROM items
  UNION ALL SELECT programada_id, 2, 'Organizador', organizador FROM items
  UNION ALL SELECT programada_id, 3, 'Nombre', nombre FROM items
  UNION ALL SELECT programada_id, 4, 'RBD', rbd FROM items
  UNION ALL SELECT programada_id, 5, 'Fecha', fecha FROM items
  UNION ALL SELECT programada_id, 6, 'Dirección', direccion FROM items
  UNION ALL SELECT programada_id, 7, 'Comuna', comuna FROM items
  UNION ALL SELECT programada_id, 8, 'Hora instalación', hora_ins FROM items
  UNION ALL SELECT programada_id, 9, 'Hora inicio', hora_ini FROM items
  UNION ALL SELECT programada_id, 10, 'Hora término', hora_fin FROM items
  UNION ALL SELECT programada_id, 11, 'Orientador/a', orientador FROM items
  UNION ALL SELECT programada_id, 12, 'Asistentes', asistentes FROM items
), roster AS (
  SELECT programada_id, asiste, CASE asiste WHEN 1 THEN 'Universidades que asisten:'
           WHEN 0 THEN 'Universidades que no asisten:' ELSE 'Universidades sin confirmación:' END AS seccion,
         CAST(n AS INTEGER) AS posicion, CAST(NULL AS VARCHAR) AS etiqueta, n || ') ' || universidad AS valor
  FROM (SELECT *, row_number() OVER (PARTITION BY programada_id, asiste ORDER BY codigo) AS n
        FROM attendance WHERE programada_id IN (SELECT programada_id FROM visits))
    LEFT JOIN universities USING (codigo)
)
SELECT programada_id, 'Información general:' AS seccion, posicion, etiqueta, valor FROM lines
UNION ALL SELECT programada_id, 'Detalle', 1, 'Asistencia/Programación', coalesce(asistentes_prog, '') FROM visits
UNION ALL SELECT programada_id, 'Detalle', 2, 'Observaciones', coalesce(observaciones, '') FROM visits
UNION ALL SELECT programada_id, seccion, posicion, etiqueta, valor FROM roster
UNION ALL
SELECT v.programada_id, 'Asistencia a visita:', 1, (SELECT universidad FROM universities WHERE codigo = 1),
       CASE a.asiste WHEN 0 THEN 'No' WHEN 1 THEN 'Sí' WHEN 2 THEN 'No confirmada' END
FROM visits v LEFT JOIN attendance a ON a.programada_id = v.programada_id AND a.codigo = 1
