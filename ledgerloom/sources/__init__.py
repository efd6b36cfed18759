"""Tables, domain views over them, and the file formats of the ledger."""
