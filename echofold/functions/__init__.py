"""Part of echofold; see the README for what lives here."""
