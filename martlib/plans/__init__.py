"""The query catalogue, its independent SQL, and the shared tables the queries run on."""
