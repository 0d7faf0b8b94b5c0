"""Table schemas, readers/writers and the test-data derivation."""
