SELECT l_partkey AS clave, count(*) AS filas FROM lineitem
WHERE l_partkey NOT IN (SELECT rbd FROM schools) GROUP BY l_partkey
