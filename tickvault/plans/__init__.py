"""Work plans (J1-J9) and request windows."""
