SELECT comuna_id, comuna FROM communes
