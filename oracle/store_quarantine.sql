, lines AS (
  SELECT programada_id, '{"programada_id":' || programada_id || ',"codigo":' || codigo || ',"asiste":' AS a,
         asiste, ',"invitacion":' || invitacion || '}' AS b
  FROM attendance WHERE programada_id % 7 = 0 OR programada_id % 11 = 0
)
SELECT CASE WHEN programada_id % 7 = 0 THEN left(a || asiste || b, -5) ELSE a || '"quizas"' || b END AS linea FROM lines
