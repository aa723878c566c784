SELECT programada_id, codigo, asiste, invitacion FROM attendance WHERE programada_id % 7 <> 0 AND programada_id % 11 <> 0
