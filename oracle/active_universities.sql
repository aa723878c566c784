SELECT codigo, universidad FROM universities
UNION ALL SELECT CAST(0 AS INTEGER), 'Usuario no acreditado'
