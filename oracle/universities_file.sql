SELECT n_nationkey AS codigo, n_name AS universidad FROM nation
