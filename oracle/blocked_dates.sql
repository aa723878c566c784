SELECT fecha, count(*) AS activas FROM visits
WHERE estatus IN ('Confirmada', 'Por confirmar') GROUP BY fecha HAVING count(*) >= (SELECT places FROM season)
