"""Tables, CSV, JSON and page extraction, and exports."""
