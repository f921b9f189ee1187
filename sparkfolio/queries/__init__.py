"""One query for each operator over the driver's tables, with the SQL that must give the same rows."""
