SELECT codigo AS value, universidad AS label FROM universities
UNION ALL SELECT CAST(0 AS INTEGER), 'Usuario no acreditado'
