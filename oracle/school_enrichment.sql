SELECT l_orderkey AS programada_id, l_linenumber AS linea, l_partkey AS rbd,
       nombre, cod_com AS comuna_id, comuna
FROM lineitem LEFT JOIN schools ON rbd = l_partkey LEFT JOIN communes ON comuna_id = cod_com
