SELECT * FROM visits
