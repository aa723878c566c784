SELECT * FROM attendance
