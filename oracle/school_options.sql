SELECT rbd AS value, nombre AS label FROM schools
