"""Every operator as a query over the driver's tables, with the same result in SQL where SQL can say it."""
