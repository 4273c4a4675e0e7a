"""DataFrame operators over texts and media payloads."""
