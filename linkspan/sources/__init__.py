"""Reading uploads, registries and documents; writing results and exports."""
