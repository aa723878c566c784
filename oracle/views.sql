WITH visits AS (
  SELECT o_orderkey AS programada_id,
         o_orderkey % 97 AS orden,
         CAST(o_custkey % 25 AS INTEGER) AS organizador_id,
         'NATION_' || CAST(o_custkey % 25 AS VARCHAR) AS organizador,
         CAST(o_orderdate AS DATE) AS fecha,
         o_custkey AS rbd,
         c_name AS nombre,
         c_mktsegment AS direccion,
         c_nationkey AS comuna_id,
         CASE WHEN o_orderkey % 11 <> 0 THEN lpad(CAST(8 + (o_orderkey % 40) // 4 AS VARCHAR), 2, '0') || ':'
           || lpad(CAST((o_orderkey % 4) * 15 AS VARCHAR), 2, '0') || ':00' END AS hora_ini,
         CASE WHEN o_orderkey % 11 <> 0 THEN lpad(CAST(9 + (o_orderkey % 40) // 4 AS VARCHAR), 2, '0') || ':'
           || lpad(CAST((o_orderkey % 4) * 15 AS VARCHAR), 2, '0') || ':00' END AS hora_fin,
         CAST(NULL AS VARCHAR) AS hora_ins,
         CAST(NULL AS VARCHAR) AS contacto,
         CAST(NULL AS VARCHAR) AS contacto_tel,
         CAST(NULL AS VARCHAR) AS contacto_mail,
         CAST(NULL AS VARCHAR) AS contacto_cargo,
         CAST(NULL AS VARCHAR) AS orientador,
         CAST(NULL AS VARCHAR) AS orientador_tel,
         CAST(NULL AS VARCHAR) AS orientador_mail,
         CAST(o_orderkey % 90 + 10 AS VARCHAR) || ' estudiantes' AS asistentes,
         CAST(NULL AS VARCHAR) AS asistentes_prog,
         CASE WHEN o_orderstatus = 'P' THEN 'Suspendida'
              WHEN o_orderstatus = 'O' THEN 'Por confirmar'
              WHEN CAST(o_orderdate AS DATE) < DATE '1998-06-15' THEN 'Realizada'
              ELSE 'Confirmada' END AS estatus,
         o_orderpriority AS observaciones,
         CASE WHEN o_orderpriority = '5-LOW' THEN least(DATE '2001-12-31', CAST(o_orderdate AS DATE) + 30)
              ELSE DATE '2001-12-31' END AS fecha_lim
  FROM orders JOIN customer ON o_custkey = c_custkey
), attendance AS (
  SELECT l_orderkey AS programada_id,
         CAST(l_suppkey % 25 AS INTEGER) AS codigo,
         max(CASE l_returnflag WHEN 'A' THEN 1 WHEN 'R' THEN 0 ELSE 2 END) AS asiste,
         min(CASE WHEN l_suppkey % 25 = o_custkey % 25 THEN 0 ELSE 1 END) AS invitacion
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey
  GROUP BY l_orderkey, l_suppkey % 25
), universities AS (
  SELECT n_nationkey AS codigo, n_name AS universidad
  FROM nation WHERE n_nationkey NOT IN (3, 5, 8, 13)
), schools AS (
  SELECT c_custkey AS rbd, c_name AS nombre, c_nationkey AS cod_com FROM customer
), communes AS (
  SELECT n_nationkey AS comuna_id, n_name AS comuna FROM nation
), holidays AS (
  SELECT dia AS fecha
  FROM (SELECT CAST(unnest(generate_series(lo, hi, INTERVAL 1 DAY)) AS DATE) AS dia
        FROM (SELECT CAST(min(o_orderdate) AS DATE) AS lo, CAST(max(o_orderdate) AS DATE) + 60 AS hi FROM orders))
  WHERE isodow(dia) > 5
     OR dia IN (DATE '1998-01-01', DATE '1998-05-01', DATE '1998-09-18', DATE '1998-12-25')
), slots AS (
  SELECT lpad(CAST(q // 4 AS VARCHAR), 2, '0') || ':' || lpad(CAST((q % 4) * 15 AS VARCHAR), 2, '0') || ':00' AS hora,
         lpad(CAST(q // 4 AS VARCHAR), 2, '0') || ':' || lpad(CAST((q % 4) * 15 AS VARCHAR), 2, '0') AS etiqueta
  FROM (SELECT unnest(generate_series(0, 95)) AS q)
), planned AS (
  SELECT * FROM visits WHERE fecha >= DATE '1998-06-15' AND estatus IN ('Confirmada', 'Por confirmar')
), typed AS (
  SELECT *, CASE WHEN fecha >= DATE '1998-06-15' AND estatus = 'Suspendida' THEN 3
                 WHEN fecha >= DATE '1998-06-15' THEN 0
                 WHEN fecha_lim <> DATE '2001-12-31' THEN 2
                 ELSE 1 END AS tipo
  FROM visits
)
, season AS (
  SELECT greatest(1, count(*) // 2700) AS places FROM orders
), holidays_and_closure AS (
  SELECT fecha FROM holidays
  UNION SELECT DATE '1997-07-07' + CAST(i AS INTEGER) FROM generate_series(0, 20) g(i)
)
-- Fixed values: the names of days and months.
, labelled AS (
  SELECT programada_id AS etiquetada, list_value('Lunes', 'Martes', 'Miércoles', 'Jueves', 'Viernes', 'Sábado', 'Domingo')[isodow(fecha)] || ', '
       || strftime(fecha, '%d') || ' de '
       || list_value('Enero', 'Febrero', 'Marzo', 'Abril', 'Mayo', 'Junio', 'Julio', 'Agosto', 'Septiembre',
                     'Octubre', 'Noviembre', 'Diciembre')[month(fecha)] || ' de ' || strftime(fecha, '%Y') AS etiqueta_fecha
  FROM visits
)
