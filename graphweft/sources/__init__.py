"""Where graphs come from: star tables, lockfiles, manifests, archives."""
