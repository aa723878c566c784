SELECT comuna_id AS value, comuna AS label FROM communes ORDER BY label, value
