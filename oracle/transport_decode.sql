SELECT * REPLACE (
  CASE WHEN programada_id % 7 = 0 OR programada_id % 11 = 0 THEN NULL ELSE fecha END AS fecha,
  CASE WHEN programada_id % 5 = 0 THEN '09:05:00' WHEN programada_id % 13 = 0 THEN NULL ELSE hora_ini END AS hora_ini,
  CASE WHEN programada_id % 17 = 0 THEN NULL ELSE hora_fin END AS hora_fin)
FROM visits
