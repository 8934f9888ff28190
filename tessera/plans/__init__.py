"""Jobs, driver-table fixtures and the registered queries."""
