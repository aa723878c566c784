SELECT programada_id, codigo, asiste, invitacion FROM attendance
