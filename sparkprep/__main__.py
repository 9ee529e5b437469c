from sparkprep.cli import main

raise SystemExit(main())
