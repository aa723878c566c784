SELECT hora AS value, etiqueta AS label FROM slots WHERE hora IN (SELECT hora_ini FROM visits) ORDER BY value
