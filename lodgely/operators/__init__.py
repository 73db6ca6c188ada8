"""Tables in, tables out: extraction, bronze, silver, gold and run reports."""
