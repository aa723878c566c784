SELECT programada_id, i.etiqueta || ' hrs.' AS hora_ini, f.etiqueta || ' hrs.' AS hora_fin,
       s.etiqueta || ' hrs.' AS hora_ins
FROM visits LEFT JOIN slots i ON i.hora = hora_ini LEFT JOIN slots f ON f.hora = hora_fin
  LEFT JOIN slots s ON s.hora = hora_ins
